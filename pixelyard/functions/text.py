"""Strings: label metadata, prompts, phrases, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_labels(text: Column) -> Column:
    """Labels from a model's metadata: the quoted parts of a dictionary, or a comma list (blanks trimmed, empty parts kept)."""
    stripped = F.trim(text)
    quoted = F.filter(F.transform(F.regexp_extract_all(stripped, F.lit("""['"]([^'"]*)['"]"""), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(stripped.startswith("{") | stripped.startswith("["), quoted).otherwise(F.transform(F.split(stripped, ","), lambda s: F.trim(s)))


def label_name(name: Column, class_id: Column) -> Column:
    """The label, or the number as text."""
    return F.coalesce(name, class_id.cast("string"))


def normalize_prompt(prompt: Column) -> Column:
    """Lower-cased and trimmed, with a final ' .'."""
    text = F.lower(F.trim(prompt))
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(" .")))


def phrase_around(tokens: Column, at: Column, stops: list[str]) -> Column:
    """The tokens between the last stop before position `at` (from 0) and the next one, joined by blanks; none if the position is a stop."""
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.element_at(tokens, i + 1).isin(*stops))
    low = F.coalesce(F.array_max(F.filter(places, lambda i: i <= at)), F.lit(-1))
    high = F.coalesce(F.array_min(F.filter(places, lambda i: i >= at)), F.size(tokens))
    return F.array_join(F.slice(tokens, low + 2, F.greatest(high - low - 1, F.lit(0))), " ")


def attribute_span(attributes: Column, name: str) -> Column:
    """The number in name="..."; null without one."""
    found = F.trim(F.regexp_extract(attributes, f'{name}="([^"]*)"', 1))
    return F.when(found.rlike("^[0-9]{1,9}$"), found).cast("int")


def palette_colour(class_id: Column) -> Column:
    """B, G, R of a class: hues by the golden angle, at saturation 0.75 and value 0.95."""
    hue = (class_id.cast("double") * 137.508) % 360
    chroma, m = 0.95 * 0.75, 0.95 - 0.95 * 0.75
    x = chroma * (1 - F.abs((hue / 60) % 2 - 1))
    sector = F.floor(hue / 60).cast("int")
    channel = lambda order: F.element_at(F.array(*[F.lit(chroma) if o == "c" else x if o == "x" else F.lit(0.0) for o in order]), sector + 1)
    byte = lambda v: F.round((v + m) * 255).cast("int")
    return F.struct(byte(channel("00xccx")).alias("b"), byte(channel("xccx00")).alias("g"), byte(channel("cx00xc")).alias("r"))
