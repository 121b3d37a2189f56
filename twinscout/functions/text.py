"""Title text as column expressions.

Everything here is built from JVM string and array functions, so it runs inside the
scan stage and never leaves the executor's JVM.  Python's idea of white space is wider
than Java's default: ``(?U)`` adds the Unicode spaces and the class below adds the four
ASCII separators that Python also counts as space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\s\x1c-\x1f"

# Words that never count as keywords.
STOP_WORDS = (
    "with", "in", "and", "for", "of", "on", "at", "a", "an", "the", "to", "from",
    "by", "is", "it", "or", "image", "1", "2", "3", "4",
)

# Numbers that are ordinary specifications, not model numbers.
SPEC_NUMBERS = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 18, 20, 22, 23, 24, 25, 26,
    30, 32, 36, 40, 45, 50, 60, 64, 80, 128, 152, 203, 256, 268, 500, 512, 520, 666,
    1000, 3500, 4000, 6000, 10000, 15000, 18000, 20000, 30000, 40000,
)

# Words that set one variant of a product apart from another.
MODIFIERS = (
    "pro", "max", "plus", "ultra", "mini", "lite", "se", "air", "series",
    "generation", "gen", "active", "sport",
)

# A run of letters, digits and inner hyphens holding at least one letter and one digit.
MODEL_CODE = r"\b(?=[0-9-]*[a-z])(?=[a-z-]*[0-9])[a-z0-9]+(?:-+[a-z0-9]+)*"
# A run of digits standing alone; group 1 leaves out leading zeros.
WHOLE_NUMBER = r"\b0*([0-9]+)\b"


def strings(values) -> Column:
    """A constant array of strings, written as one literal that the optimizer folds."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def sku_key(col: Column) -> Column:
    """The join key for scores: trimmed and upper-cased."""
    return F.upper(strip(col))


def clean_title(col: Column) -> Column:
    """Lower case, everything but letters, digits, spaces and hyphens blanked out."""
    kept = F.regexp_replace(F.lower(col), rf"(?U)[^a-z0-9{SPACE}-]", " ")
    one_word = F.replace(kept, F.lit("rear view"), F.lit("rearview"))
    two_words = F.replace(one_word, F.lit("rearviewmirror"), F.lit("rearview mirror"))
    return F.coalesce(two_words, F.lit(""))


def _words(clean: Column) -> Column:
    return F.split(clean, rf"(?U)[{SPACE}]+")


def _keywords(words: Column) -> Column:
    return F.array_except(words, strings(("",) + STOP_WORDS))


def _models(clean: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(MODEL_CODE), F.lit(0)))


def _numbers(clean: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(WHOLE_NUMBER), F.lit(1)))


def _telling(numbers: Column) -> Column:
    return F.array_sort(F.array_except(numbers, strings(SPEC_NUMBERS)))


def _modifiers(words: Column) -> Column:
    return F.array_sort(F.array_intersect(words, strings(MODIFIERS)))


def title_keywords(title: Column) -> Column:
    """Distinct words of the cleaned title without the stop words."""
    return _keywords(_words(clean_title(title)))


def model_codes(title: Column) -> Column:
    """Distinct tokens that mix letters and digits."""
    return _models(clean_title(title))


def title_numbers(title: Column) -> Column:
    """Distinct whole numbers as text without leading zeros, so no width can overflow."""
    return _numbers(clean_title(title))


def telling_numbers(title: Column) -> Column:
    """Sorted numbers of the title that are not ordinary specifications."""
    return _telling(title_numbers(title))


def title_modifiers(title: Column) -> Column:
    """Sorted variant words present in the title."""
    return _modifiers(_words(clean_title(title)))


def _features(clean: Column, words: Column) -> Column:
    return F.struct(
        _keywords(words).alias("keywords"),
        _models(clean).alias("models"),
        _telling(_numbers(clean)).alias("numbers"),
        _modifiers(words).alias("modifiers"),
    )


def title_features(title: Column) -> Column:
    """All per-title facts the pair rules need, as one struct."""
    clean = clean_title(title)
    return _features(clean, _words(clean))


def with_features(df: DataFrame, title: str, name: str) -> DataFrame:
    """Add ``title_features`` as a column.  Cleaning and splitting are columns of their
    own, which the optimizer does not inline into their several uses, so every title is
    read once.  Do this per title, before pairs are made."""
    return (
        df.withColumn("_clean", clean_title(F.col(title)))
        .withColumn("_words", _words(F.col("_clean")))
        .withColumn(name, _features(F.col("_clean"), F.col("_words")))
        .drop("_clean", "_words")
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared keywords over the smaller keyword set; 0.0 when either set is empty."""
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def model_conflict(a: Column, b: Column) -> Column:
    """Both titles name models and none is shared."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def number_conflict(a: Column, b: Column) -> Column:
    """Some ``telling_numbers`` value is in exactly one title.  Both arrays are sorted and
    without the tolerated values, so this is plain inequality."""
    return a != b


def modifier_conflict(a: Column, b: Column) -> Column:
    """Some ``title_modifiers`` word is in exactly one title; sorted arrays again."""
    return a != b


def strict_mismatch(a: Column, b: Column) -> Column:
    """Two ``title_features`` structs describe different products."""
    return (
        model_conflict(a["models"], b["models"])
        | number_conflict(a["numbers"], b["numbers"])
        | modifier_conflict(a["modifiers"], b["modifiers"])
    )
