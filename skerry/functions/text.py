"""Text rules as column expressions: anchors that survive translation, wording detectors, positions, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that outputs are checked against. English and Spanish wording of the duty to carry AIS; zone ids,
# legal references and figures with either decimal separator; verbs beyond an inspector's authority; a leading distance;
# claims that ids belong to a class. All are Unicode patterns: white space, digits and word edges are those of Unicode.
SPACE = r"[\s\x1C-\x1F]"
AIS_WORDING = rf"(?U)\bais\b|carriage requirement|article{SPACE}*10|art[íi]culo{SPACE}*10|\bart\.?{SPACE}*10\b|1224/2009|reglamento{SPACE}*\(ce\){SPACE}*n?\S*{SPACE}*1224"
ANCHOR = r"(?U)[A-Z]{2,4}-\d{2,}|\d{4}/\d{4}|\d+[.,]\d+"
DASHES = "‐‑‒–—―"
FORBIDDEN_VERBS = r"(?U)\b(seize|confiscate|arrest|impound|incautar|detener|apresar|confiscar)\b"
NUMBER = r"(?U)-?\d+(?:\.\d+)?"
LEADING_DISTANCE = rf"(?Ui)^[\d.,]+{SPACE}*(km|nm|miles)\b[^:.]*[:.]?{SPACE}*"
LONG_WORD = r"[a-z]{4,}"
NOTHING_NAMED = r"none identified|not applicable"
ID = r"D-\d+"
_DASH = r"[\s\x1C-\x1F\x{2010}-\x{2015}-]*"
CLAIM_IN_BRACKETS = rf"(?Ui)(high|medium){_DASH}priority((?:(?!high{_DASH}priority|medium{_DASH}priority)[^.(]){{0,100}})\(([^)]*)\)"
CLAIM_BARE = (
    rf"(?Ui)(high|medium){_DASH}priority{SPACE}+(?:[a-zA-Z]+{SPACE}+){{0,3}}"
    rf"({{id}}(?:(?:{SPACE}*,{SPACE}*|{SPACE}+and{SPACE}+){{id}})*)"
)


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at either end; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def mentions_ais(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(AIS_WORDING)


def plain_dashes(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DASHES, "-" * len(DASHES))


def anchors(text: Column) -> Column:
    """Distinct anchors, figures with a decimal point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(plain_dashes(text), F.lit(ANCHOR), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("."))))


def position(value: Column) -> Column:
    """struct(lat, lon) of a {lat, lon} object in JSON or of the first two numbers of a text; null where there are none."""
    lat, lon = F.get_json_object(value, "$.lat"), F.get_json_object(value, "$.lon")
    numbers = F.regexp_extract_all(value, F.lit(NUMBER), F.lit(0))
    a, b = F.get(numbers, F.lit(0)).try_cast("double"), F.get(numbers, F.lit(1)).try_cast("double")
    is_object = F.ltrim(value).startswith("{")
    y, x = F.when(is_object, lat.try_cast("double")).otherwise(a), F.when(is_object, lon.try_cast("double")).otherwise(b)
    return F.when(y.isNotNull() & x.isNotNull(), F.struct(y.alias("lat"), x.alias("lon")))


def position_text(value: Column) -> Column:
    """A position for display: an object as "lat, lon", a text as it is."""
    return F.when(F.ltrim(value).startswith("{"), F.concat_ws(", ", F.get_json_object(value, "$.lat"), F.get_json_object(value, "$.lon"))).otherwise(value)


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LONG_WORD), F.lit(0))


def instruction(action: Column) -> Column:
    """What remains of an action when a leading distance is set aside."""
    return stripped(F.regexp_replace(stripped(action), LEADING_DISTANCE, ""))


def below_claim(threshold: float) -> str:
    n = int(threshold)
    return rf"(?U)(under|below|less than){SPACE}*{n}|menos de{SPACE}*{n}|not meet|no alcanza"


def claims(prose: Column, id_pattern: str = ID) -> Column:
    """array of struct(claimed class, list text): explicit claims that ids belong to a priority class, in order."""
    def pair(pattern: str, k: int) -> Column:
        found = [F.regexp_extract_all(prose, F.lit(pattern), F.lit(n)) for n in (1, k)]
        return F.zip_with(*found, lambda c, listed: F.struct(F.concat(F.lower(c), F.lit("_priority")).alias("claimed"), listed.alias("listed")))

    return F.concat(pair(CLAIM_IN_BRACKETS, 3), pair(CLAIM_BARE.replace("{id}", id_pattern), 2))


def degenerate(text: Column, least_chars: int = 2000, least_sentences: int = 20, ratio: float = 0.1) -> Column:
    """A long text without an object that says the same sentences again and again."""
    sentences = F.filter(F.transform(F.split(text, "[.]"), stripped), lambda s: s != "")
    n = F.size(sentences)
    return F.coalesce(
        (F.char_length(text) >= least_chars) & ~F.contains(text, F.lit("{")) & (n >= least_sentences) & (F.size(F.array_distinct(sentences)) < ratio * n),
        F.lit(False)
    )


def repaired(fragment: Column) -> Column:
    """Without comment lines and commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(fragment, r"(?mU)^\s*//.*$", ""), r"(?U),(\s*[}\]])", "$1")


def unfenced(text: Column) -> Column:
    """The first part between code fences that holds an object, or the text itself."""
    parts = F.filter(F.split(stripped(text), "```"), lambda p: F.contains(p, F.lit("{")))
    first = F.get(parts, F.lit(0))
    return F.when(F.contains(text, F.lit("```")) & first.isNotNull(), F.regexp_replace(first, r"(?U)^\s*json", "")).otherwise(stripped(text))


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text; braces inside strings do not count. Null where there is none or it never closes.

    No regular expression counts depth, so the text is cut into marks (braces, quotes, escapes, the rest between them) and
    a fold keeps the depth, whether a string is open, and where the object ends.
    """
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substr(text, start))
    marks = F.regexp_extract_all(rest, F.lit(r"(?s)\\.|[{}\"]|[^\\{}\"]+|\\$"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, m: Column) -> Column:
        quote, inside = m == F.lit('"'), a.open
        depth = F.when(inside, a.depth).when(m == "{", a.depth + 1).when(m == "}", a.depth - 1).otherwise(a.depth)
        at = a.at + F.char_length(m)
        closes = ~inside & (m == "}") & (a.depth == 1)
        moved = F.struct(
            depth.alias("depth"), F.when(quote, ~inside).otherwise(inside).alias("open"), at.alias("at"),
            F.when(closes, at).otherwise(F.lit(0)).alias("end")
        )
        return F.when(a.end > 0, a).otherwise(moved)

    end = F.aggregate(marks, zero, step)["end"]
    return F.when(end > 0, F.substr(rest, F.lit(1), end))


def parsed(text: Column) -> Column:
    """A VARIANT of the object in a model's answer: as it stands, else repaired; null where neither parses."""
    fragment = first_object(unfenced(text))
    return F.coalesce(F.try_parse_json(fragment), F.try_parse_json(repaired(fragment)))
