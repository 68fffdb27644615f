"""Column functions for identifiers, names, postcodes and free text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING_NUMBER = ("", "NAN", "NONE", "NULL", "N/A")
MISSING_POSTCODE = ("", "NAN", "NONE", "NULL", "NAT", "NA", "N/A", "UNKNOWN", "UNSPECIFIED", "-")
MISSING_TEXT = ("nan", "nat", "none")
MISSING_LOOKUP = ("", "NAN", "NONE")
# Legal forms taken off a name's end, and words taken out anywhere in it.
TRAILING_FORMS = ("LIMITED", "LTD", "PLC", "LLP", "CIC", "CIO")
LOOSE_WORDS = ("LIMITED", "LTD", "PLC", "PUBLIC LIMITED COMPANY", "LLP", "LIMITED LIABILITY PARTNERSHIP", "LP", "CIC", "CIO", "COMPANY", "CO", "AND", "THE")
ENDINGS = ("LIMITED", "LTD", "PLC", "LLP", "LP", "CIC", "INC", "CORP", "CORPORATION", "GROUP", "HOLDINGS", "COMPANY", "CO")
LAST_FORMS = ("LIMITED", "LTD", "PLC", "LLP", r"L\.T\.D\.")
SEARCH_FORMS = ("LIMITED", "LTD", "PLC", "LLP", "CIC", "CIO", "COMPANY", "CO", "HOLDINGS", "GROUP")


def _padded(s: Column) -> Column:
    return F.lpad(s, F.greatest(F.lit(8), F.length(s)), "0")  # a pad never cuts


def company_number(raw: Column, mode: str = "prefix") -> Column:
    """An eight-letter register number or null. Five cleaners, which differ on purpose:

    prefix: marks go; letters in front stay in front (SC12345 is SC012345); what is longer than eight or no number is null.
    plain: spaces go; zeros in front of all (0SC12345); digits of any length stay, other values longer than eight are null.
    lookup: as plain, but longer values stay as they are. digits: zeros in front of digits, all else as it is, upper-cased.
    zeros: zeros in front of whatever there is, the empty text too."""
    s = F.upper(F.trim(raw))
    if mode == "prefix":
        bare = F.regexp_replace(s, "[^A-Z0-9]", "")
        number = F.when(bare.rlike("^[0-9]+$"), _padded(bare)).when(bare.rlike("^[A-Z]{2}[0-9]+$"), F.concat(F.substring(bare, 1, 2), F.lpad(F.substring(bare, 3, 8), 6, "0")))
        return F.when(~s.isin(*MISSING_NUMBER) & F.length(bare).between(1, 8), number)
    if mode in ("plain", "lookup"):
        bare = F.replace(s, F.lit(" "), F.lit(""))
        known = ~bare.isin(*MISSING_LOOKUP)
        return F.when(known if mode == "lookup" else known & (bare.rlike("^[0-9]+$") | (F.length(bare) <= 8)), _padded(bare))
    if mode == "digits":
        return F.when(~s.isin("", "NAN"), F.when(s.rlike("^[0-9]+$"), _padded(s)).otherwise(s))
    if mode == "zeros":
        return _padded(s)
    raise ValueError(f"mode is prefix, plain, lookup, digits or zeros, not {mode!r}")


def company_name(raw: Column, mode: str = "trailing") -> Column:
    """A comparable name or null. Six cleaners, which differ on purpose:

    trailing: marks are dropped and legal forms at the end taken off. anywhere: marks become spaces and legal forms, AND
    and THE go wherever they stand. lower: lower case, marks become spaces. readable: endings go one after the other, with
    the marks between, and words are capitalised. last: one legal form at the end goes, all else stays. search: marks but &
    become spaces and the forms of search phrases go wherever they stand."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    if mode == "trailing":
        s = F.regexp_replace(F.upper(F.regexp_replace(raw, "[^A-Za-z0-9 ]", "")), r"\s+", " ")
        s = F.trim(F.regexp_replace(s, f"( {'| '.join(TRAILING_FORMS)})+$", ""))
    elif mode == "anywhere":
        s = squeezed(F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9 ]", " "), rf"\b({'|'.join(LOOSE_WORDS)})\b", " "))
    elif mode == "lower":
        s = squeezed(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    elif mode == "readable":
        # an ending is a space, a form and what closes it; the whole run of them goes at once
        s = F.regexp_replace(F.trim(F.upper(raw)), rf"(\s({'|'.join(ENDINGS)})[\s,.]*)+$", "")
        s = F.initcap(F.lower(F.regexp_replace(F.trim(s), r"[\s,.]+$", "")))
    elif mode == "last":
        s = F.trim(F.regexp_replace(raw, rf"(?i)\s+({'|'.join(LAST_FORMS)})\.?\s*$", ""))
    elif mode == "search":
        s = squeezed(F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9 &]", " "), rf"\b({'|'.join(SEARCH_FORMS)})\b", " "))
    else:
        raise ValueError(f"mode is trailing, anywhere, lower, readable, last or search, not {mode!r}")
    return F.nullif(s, F.lit(""))


def stands_alone(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text as a whole: no letter, digit, underscore or hyphen touches it."""
    quoted = F.regexp_replace(phrase, r"([\\\[\](){}.*+?^$|#&~\-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), quoted, F.lit(r"(?![\p{L}\p{N}_-])")))


def postcode(raw: Column) -> Column:
    """Upper case without spaces, or null; texts for a missing value never become a postcode."""
    s = F.upper(F.trim(raw))
    bare = F.regexp_replace(s, "[^A-Z0-9]", "")
    return F.when(~s.isin(*MISSING_POSTCODE) & ~bare.isin(*MISSING_POSTCODE), bare)


def postcode_outward(raw: Column) -> Column:
    """All but the last three letters of a postcode of at least four."""
    s = postcode(raw)
    return F.when(F.length(s) >= 4, F.substring(s, F.lit(1), F.length(s) - 3))


def postcode_area(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(postcode(raw), "^([A-Z]{1,2})", 1), F.lit(""))


POSTCODE_PATTERN = r"([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})"


def postcode_in(text: Column, which: str = "first") -> Column:
    """The first or last postcode that stands in a text, normalised, or null."""
    found = F.regexp_extract_all(F.upper(text), F.lit(POSTCODE_PATTERN), F.lit(1))
    return postcode(F.get(found, F.lit(0)) if which == "first" else F.get(found, F.size(found) - 1))


# Named entities that pages of notices use, beside the numbered ones.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "pound": "£", "euro": "€", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "frac12": "½", "deg": "°", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "times": "×",
}


def unescaped(text: Column) -> Column:
    """Named and numbered entities as letters, each once: what an entity gives is not read again."""
    # the text between entities stays; each entity is looked up on its own
    parts = F.regexp_extract_all(text, F.lit("(?s)&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    named = F.create_map(*[F.lit(x) for k, v in (ENTITIES | {"amp": "&"}).items() for x in (f"&{k};", v)])
    letter = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    whole = lambda p: F.when(p.rlike("^&#[0-9]{1,7};$"), F.regexp_extract(p, "[0-9]+", 0).try_cast("long")).when(p.rlike("^&#[xX][0-9A-Fa-f]{1,6};$"), F.conv(F.regexp_extract(p, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).try_cast("long"))
    said = lambda p: F.when(p.startswith("&"), F.coalesce(F.try_element_at(named, p), letter(whole(p)), p)).otherwise(p)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, said), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """A page's text: scripts, styles and comments go, tags become a space, entities are letters, runs of space one space."""
    s = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    s = unescaped(F.regexp_replace(s, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(s, r"[\s\u00a0]+", " "))


def no_missing_words(raw: Column) -> Column:
    """Null for texts that only say that a value is missing."""
    return F.when(~F.lower(F.trim(raw)).isin(*MISSING_TEXT), raw)


def price(raw: Column) -> Column:
    """A number from a printed price; blanks, other text and zero are null."""
    return F.nullif(F.regexp_replace(raw, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def labelled_number(text: Column, *labels: str) -> Column:
    """The digits after the first label that has some."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?i){label}\s*:?\s*([A-Z0-9]{{6,8}})", 1), F.lit("")) for label in labels])


def detail_line(*parts: Column, most: int = 120, joined_by: str = " | ") -> Column:
    return F.substring(F.concat_ws(joined_by, *parts), 1, most)


def first_match(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first group with a pattern that the text holds. Worth calling on distinct texts only: see classify_distinct()."""
    out = None
    for group, patterns in rules:
        hit = text.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)
