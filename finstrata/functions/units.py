"""Amounts and their units as people write them: numbers in several styles, scales, currencies and minor units."""

from __future__ import annotations

import re
from decimal import Decimal

# Words for scales, lower case, without points.
SCALES = {
    1: "ones one actuals actual units unit".split(),
    10**3: ["k", "000s", "'000", "’000", "000", "thousand", "thousands", "tsd", "tausend", "millier", "milliers", "miles", "mil", "mila", "migliaia", "duizend", "tusind", "t", "th", "ths", "td", "tn k"],
    10**6: ["m", "mm", "mn", "mln", "mio", "million", "millions", "millionen", "millón", "millon", "millones", "milione", "milioni", "miljoen", "millioner"],
    10**8: ["億", "亿", "hundred millions", "hundred million"],
    10**9: ["b", "bn", "billion", "billions", "mrd", "mld", "md", "mds", "mia", "milliard", "milliards", "milliarden", "miljard", "milliarder", "miliardo", "miliardi", "mil millones", "thousand millions", "thousand million"],
}
# Names of currencies, lower case, and of their hundredths.
CURRENCIES = {
    "EUR": ["eur", "euro", "euros", "€"], "USD": ["usd", "us$", "$", "us dollar", "us dollars", "dollars", "u.s. dollars"], "GBP": ["gbp", "£", "pound sterling", "pounds sterling", "pounds", "sterling"],
    "CHF": ["chf", "sfr", "sfr.", "fr", "fr.", "swiss franc", "swiss francs", "francs"], "JPY": ["jpy", "¥jpy", "jp¥", "yen", "円", "¥", "japanese yen"], "CNY": ["cny", "rmb", "renminbi", "yuan", "cn¥", "元", "人民币", "¥cny"],
    "HKD": ["hkd", "hk$", "hong kong dollars", "hong kong dollar"], "AUD": ["aud", "a$", "au$", "australian dollars", "australian dollar"], "CAD": ["cad", "c$", "ca$", "canadian dollars", "canadian dollar"],
    "DKK": ["dkk", "dkr", "dkr.", "danish kroner", "danish krone", "kr dkk"], "SEK": ["sek", "skr", "swedish kronor", "swedish krona"], "NOK": ["nok", "nkr", "norwegian kroner", "norwegian krone"],
    "SAR": ["sar", "saudi riyals", "saudi riyal", "riyals", "sr"], "INR": ["inr", "₹", "rupees", "indian rupees"], "SGD": ["sgd", "s$", "singapore dollars"], "KRW": ["krw", "₩", "won"], "PLN": ["pln", "zł", "zloty"], "BRL": ["brl", "r$", "reais"],
}
MINOR = {
    "EUR": ["euro cents", "euro cent", "eur cent", "eur cents", "cents (eur)", "eurocent", "eurocents", "c (eur)"], "USD": ["us cents", "us cent", "cents (usd)", "usd cents", "usd cent", "cents"],
    "GBP": ["pence", "penny", "gbx", "p (sterling)", "p", "pence sterling", "gbp pence", "gbp pence"], "CHF": ["rappen", "centimes (chf)", "chf centimes", "rp", "rp."], "SEK": ["öre (sek)", "öre", "sek öre", "swedish öre"],
    "DKK": ["øre (dkk)", "øre", "dkk øre", "danish øre"], "NOK": ["øre (nok)", "nok øre", "norwegian øre"], "HKD": ["hk cents", "cents (hkd)"], "AUD": ["australian cents", "cents (aud)"], "CAD": ["canadian cents", "cents (cad)"],
}
_SCALE_OF = {w: s for s, words in SCALES.items() for w in words}
_CURRENCY_OF = {w: (c, 1) for c, words in CURRENCIES.items() for w in words} | {w: (c, 100) for c, words in MINOR.items() for w in words}
ISO = frozenset(CURRENCIES) | frozenset(MINOR)
_WORDS = sorted({*_SCALE_OF, *_CURRENCY_OF}, key=len, reverse=True)
_LETTER = r"[^\W\d_]"
_UNIT = re.compile("|".join(rf"{'(?<!' + _LETTER + ')' if w[0].isalpha() else ''}{re.escape(w)}{'(?!' + _LETTER + ')' if w[-1].isalpha() else ''}" for w in _WORDS))
_MARKS = r"(bn|b|mn|mln|m|k|t|tsd|mio|mrd|th|'000|’000|000)\.?"
_ISO_SCALE = (re.compile(rf"^(?P<iso>[A-Za-z]{{3}})[ ]?(?P<mark>{_MARKS})$", re.I), re.compile(rf"^(?P<mark>{_MARKS})[ ]?(?P<iso>[A-Za-z]{{3}})$", re.I))
_SPACES = "   "
_NUMBER = re.compile(rf"\d(?:[\d.,'’{_SPACES} ]*\d)?")


def read_units(text: str | None) -> tuple[str | None, int, int | None]:
    """(currency, minor units to one, scale) that a text names; None for what it doesn't name."""
    if not text or not text.strip():
        return None, 1, None
    low = re.sub(r"\s+", " ", text.strip())
    for pattern in _ISO_SCALE:
        m = pattern.match(low)
        if m and m["iso"].upper() in ISO:
            mark = m["mark"].lower().rstrip(".")
            return m["iso"].upper(), 1, _SCALE_OF["k" if mark == "t" else mark]
    if re.fullmatch("[A-Z]{3}", low) and low.lower() not in _SCALE_OF and low.lower() not in _CURRENCY_OF:
        return low, 1, None  # a code that no list here names
    currency, minor, scale = None, 1, None
    for m in _UNIT.finditer(low.lower().strip(" .") if len(low) > 1 else low.lower()):
        word = m.group()
        if word in _CURRENCY_OF and currency is None and not (word in ("p", "fr", "sr", "rp") and len(low) > 14):
            currency, minor = _CURRENCY_OF[word]
        elif word in _SCALE_OF and scale is None:
            scale = _SCALE_OF[word]
    return currency, minor, scale


def read_number(text: str | None) -> tuple[Decimal | None, str]:
    """(the signed number in a text, the text without it); None if there is none."""
    if not text:
        return None, ""
    shown = re.sub(r"['’]000\b(?!\d)", lambda m: " \x01 " if m.start() == 0 or not text[m.start() - 1].isdigit() or not re.search(r"\d['’]\d{3}", text[max(0, m.start() - 4) : m.end()]) else m.group(), text)
    m = _NUMBER.search(shown)
    if not m:
        return None, shown.replace("\x01", "'000")
    rest = (shown[: m.start()] + " \x02 " + shown[m.end() :]).replace("\x01", "'000")
    digits = re.sub(rf"['’{_SPACES} ]", "", m.group())
    commas, points = digits.count(","), digits.count(".")
    if commas and points:
        last = max(digits.rfind(","), digits.rfind("."))
        digits = re.sub(r"[.,]", "", digits[:last]) + "." + digits[last + 1 :]
    elif commas:
        grouped = re.fullmatch(r"\d{1,3}(?:,\d{3})+", digits)
        digits = digits.replace(",", "") if grouped else digits.replace(",", ".") if commas == 1 else digits.replace(",", "")
    elif points > 1:
        digits = digits.replace(".", "")
    value = Decimal(digits)
    negative = re.search(r"(?:^\s*[-−–—][^\d(]{0,30}|[-−–—]\s*)\x02", rest) or re.search(r"\x02\s*[-−–](?!\w)", rest) or re.search(r"\(\s*\x02\s*\)", rest)
    return (-value if negative else value), re.sub(r"\x02", " ", rest)


PLAIN = re.compile(r"-?\d+")
