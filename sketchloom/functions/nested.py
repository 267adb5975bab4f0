"""Arrays of arrays of strings out of JSON text, malformed rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_arrays(text: Column) -> Column:
    """A struct (value, bad) of a JSON array of arrays.

    ``value`` is the array of arrays of strings; numbers, truths and objects
    within are their JSON text, and a null stays null.  Blank text is an empty
    array.  Where the text is anything else (another type, an inner element that
    is no array, an end that is missing or text behind it) value is null and
    ``bad`` holds the text.  A null text has both null.
    """
    wrapped = F.concat(F.lit('{"v":'), text, F.lit("}"))
    parsed = F.from_json(wrapped, "v array<array<string>>, bad string", {"columnNameOfCorruptRecord": "bad"})
    whole = parsed["bad"].isNull() & parsed["v"].isNotNull() & F.forall(parsed["v"], lambda x: x.isNotNull()) & (F.size(F.json_object_keys(wrapped)) == 1)
    blank = F.trim(text) == ""
    none = F.array().cast("array<array<string>>")
    value = F.when(blank, none).when(whole, parsed["v"])
    return F.struct(value.alias("value"), F.when(text.isNotNull() & ~blank & ~F.coalesce(whole, F.lit(False)), text).alias("bad"))


def to_json_arrays(value: Column) -> Column:
    """The JSON text of an array of arrays of strings."""
    return F.to_json(value)
