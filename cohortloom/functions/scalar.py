"""Column expressions over barcodes, run ids, labels and nested values; all of them run inside Spark's codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Barcode and run-id patterns, and the sample codes of tumour and normal tissue.
PRIMARY_BARCODE = "TCGA-[A-Z0-9]+-[A-Z0-9]+-01"
SAMPLE_BARCODE = "TCGA-[A-Za-z0-9]+-[A-Za-z0-9]+-[0-9]+"
RUN_ID = "[0-9]+-[0-9]+"
SAMPLE_TYPES = {"01": "TP", "11": "NT"}
RUN_ID_FORMAT = "yyyyMMdd-HHmmss"


def drop_last_char(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def matched(text: Column, pattern: str) -> Column:
    """The first match of ``pattern``, or null if there is none."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def without_suffix(text: Column, suffix_pattern: str) -> Column:
    return F.regexp_replace(text, suffix_pattern, "")


def barcode_part(barcode: Column, number: int) -> Column:
    """Part ``number`` (from 1) of a barcode split on ``-``, null past the end."""
    return F.get(F.split(barcode, "-"), number - 1)


def barcode_parts(barcode: Column, first: int) -> Column:
    """The first parts of a barcode, joined again."""
    return F.array_join(F.slice(F.split(barcode, "-"), 1, first), "-")


def sample_type(barcode: Column) -> Column:
    """TP for a primary tumour, NT for normal tissue, else null, from the two-digit sample code."""
    code = F.substring(barcode_part(barcode, 4), 1, 2)
    kind = F.lit(None).cast("string")
    for value, name in SAMPLE_TYPES.items():
        kind = F.when(code == value, name).otherwise(kind)
    return kind


def log2p1(value: Column) -> Column:
    return F.log2(value + 1)


def percent_text(part: Column, whole: Column) -> Column:
    share = part * 100.0 / F.nullif(whole, F.lit(0))
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share))


def floor_fraction(count: Column, ratio: float) -> Column:
    return F.floor(count * F.lit(ratio))


def bit_string(mask: Column, width: int) -> Column:
    return F.lpad(F.bin(mask), width, "0")


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def kept_items(items: Column) -> Column:
    """The list without nulls and empty texts."""
    return F.filter(items, lambda item: item.isNotNull() & (item != ""))


def distinct_joined(text: Column, separator: str = ";") -> Column:
    """Split, drop empty items, remove repeats, sort and join again."""
    return F.array_join(distinct_items(text, separator), separator)


def distinct_items(text: Column, separator: str = ";") -> Column:
    return F.array_sort(F.array_distinct(kept_items(F.split(text, separator))))


def text_or_list(raw: Column, separator: str = ";") -> tuple[Column, Column]:
    """Joined text and item count of a JSON value that is a list of texts or one text."""
    listed = F.from_json(raw, "array<string>")
    is_list = F.trim(raw).startswith("[")
    bare = F.regexp_replace(raw, '^"|"$', "")
    return (
        F.when(is_list, F.array_join(listed, separator)).otherwise(bare),
        F.when(is_list, F.size(listed)).when(raw.isNotNull(), 1).cast("int"),
    )


def interaction_text(name: Column, score: Column, types: Column) -> Column:
    """``name;score;type&type`` of one interaction."""
    return F.concat_ws(";", name, score.cast("string"), F.array_join(types, "&"))


def null_if_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def run_id_of(moment: Column) -> Column:
    return F.date_format(moment, RUN_ID_FORMAT)
