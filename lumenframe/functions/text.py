"""Text, JSON and catalogue expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: key, and quoted text, number or truth value.
SETTING = r'(\w+)\s*=\s*("[^"]*"|-?[\d.]+|true|false)'
SENTINEL = -999999


def settings_map(text: Column) -> Column:
    """All settings of a text as a map; of a repeated key the last value holds."""
    keys, values = F.regexp_extract_all(text, F.lit(SETTING), F.lit(1)), F.regexp_extract_all(text, F.lit(SETTING), F.lit(2))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i")))
    last = lambda all_pairs: F.filter(all_pairs, lambda x: ~F.exists(all_pairs, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    # bound as a lambda's argument, so that the patterns run once for each text and not for each pair
    kept = F.get(F.transform(F.array(pairs), last), F.lit(0))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r'^"|"$', "")


def number(value: Column, default: float = 0.0) -> Column:
    """A number; the default where it is missing, not a number, or the catalogue's mark for unset."""
    parsed = value.try_cast("double")
    return F.coalesce(F.when(parsed > SENTINEL, parsed), F.lit(float(default)))


def exclusion_reason(settings: Column, raw: Column, rotated: Column) -> Column:
    """Why an edit isn't fitted: the first that holds."""
    keys = F.map_keys(settings)
    return (
        F.when(F.exists(keys, lambda k: k.startswith("GrayMixer")), "grayscale")
        .when(F.element_at(settings, "ConvertToGrayscale") == "true", "grayscale")
        .when(raw.contains("PaintBasedCorrections") | raw.contains("GradientBasedCorrections"), "local")
        .when(F.exists(keys, lambda k: k.startswith("Crop")), "crop")
        .when(rotated, "rotated")
    )


def notes(settings: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(number(F.element_at(settings, "Clarity2012")) != 0, "clarity"),
            F.when(unquoted(F.element_at(settings, "ToneCurveName")) == "Medium Contrast", "medium-contrast-curve"),
        )
    )


def path_quoted(path: Column) -> Column:
    """Percent encoding of a path: spaces are %20, and slashes stay."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(path), r"\+", "%20"), "%2F", "/")


def mired_shift(kelvin: Column, reference: Column) -> Column:
    """1e6/k - 1e6/reference; a zero counts as missing and gives no shift."""
    return F.coalesce(1e6 / F.nullif(kelvin, F.lit(0.0)) - 1e6 / F.nullif(reference, F.lit(0.0)), F.lit(0.0))


def project_name(file: Column, day: Column) -> Column:
    """A file's stem, 120 characters at most; Untitled and the day where nothing is left."""
    stem = F.trim(F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    return F.when(stem == "", F.concat(F.lit("Untitled "), F.date_format(day, "yyyy-MM-dd"))).otherwise(F.left(stem, F.lit(120)))


def extension(content_type: Column) -> Column:
    t = F.lower(content_type)
    return F.when(t == "image/png", ".png").when(t == "image/webp", ".webp").when(t == "image/tiff", ".tif").otherwise(".jpg")


def fitted_size(width: Column, height: Column, longest: int) -> Column:
    """Size with the longer side at most longest; halves round to even, and no side is less than 1."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    side = lambda x: F.when(scale >= 1, x).otherwise(F.greatest(F.lit(1), F.bround(x * scale).cast("int")))
    return F.struct(side(width).alias("width"), side(height).alias("height"))
