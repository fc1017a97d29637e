r"""Fill-in-the-middle samples by escaped marker injection, in DataFrame functions alone.

A delimiter that no text holds after escaping is put after every unit of the text by one
``regexp_replace``; counting it counts the units, and ``substring_index`` cuts after the unit of any
rank. What stands between two ranks is one part; delimiters go, escapes are undone, and the parts are
put together around the sentinels. Nothing is exploded and nothing is shuffled: a row is one
expression in generated code, whatever the length of its text.

The escapes keep units apart as they were: delimiter, escape and what follows it are no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts

#: Fixed value: a unit is a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, the escape, and what they are in an escaped text.
_DELIMITER, _ESCAPE = "\x01", "\x02"
_ESCAPES = ((_ESCAPE, _ESCAPE + "e"), (_DELIMITER, _ESCAPE + "d"))


def escaped(text: Column) -> Column:
    """The text without a delimiter in it."""
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(marked: Column) -> Column:
    """A stretch of units as it stood in the text: without delimiters, escapes undone."""
    text = F.replace(marked, F.lit(_DELIMITER), F.lit(""))
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def marked(text: Column) -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), f"({UNIT})", "$1" + _DELIMITER)


def _units(column: str, begin: Column, end: Column) -> Column:
    """Units ``begin`` + 1 to ``end`` of a marked column: the first ``end`` of it, and of these the last ones."""
    head = F.call_function("substring_index", F.col(column), F.lit(_DELIMITER), end)
    return unescaped(F.call_function("substring_index", head, F.lit(_DELIMITER), begin - end))


def _rest(column: str, begin: Column, n: Column) -> Column:
    """Units after ``begin``; behind the last delimiter there is one more, empty, part."""
    return unescaped(F.call_function("substring_index", F.col(column), F.lit(_DELIMITER), begin - n - 1))


def _draws(seed: int) -> list[Column]:
    """Four numbers of 32 bits that seed and doc_id fix. A row without a doc_id draws as for an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``doc_id, text, n, form, prefix, middle, suffix, output``: each text once, as it is or with its middle moved to the end.

    ``percent`` of the texts are transformed, of these ``spm_percent`` in the order suffix, prefix, middle
    and the others in the order prefix, suffix, middle. Cuts are after a number of units that seed and
    doc_id draw. The parts are null where the form is plain.

    Null and empty texts are plain and have no unit; a text that holds a sentinel stays plain, so an
    output can always be undone. Texts of white space alone are one unit. Repeated rows give equal rows.
    Very long texts go through whole. Extra columns are ignored; an empty table gives no rows.
    """
    h1, h2, h3, h4 = _draws(seed)
    out = texts(docs).withColumns({"h1": h1, "h2": h2, "h3": h3, "h4": h4, "marked": marked(F.col("text"))})
    n = F.char_length("marked") - F.char_length(escaped(F.col("text")))
    sentinel = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= percent) | sentinel
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumns({"n": n.cast("long"), "form": form})
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    out = out.withColumns({"low": F.least(one, two).cast("int"), "high": F.greatest(one, two).cast("int")})
    cut = F.col("form") != "plain"
    parts = {
        "prefix": _units("marked", F.lit(0), F.col("low")),
        "middle": _units("marked", F.col("low"), F.col("high")),
        "suffix": _rest("marked", F.col("high"), F.col("n").cast("int")),
    }
    out = out.select("doc_id", "text", "n", "form", *[F.when(cut, value).alias(name) for name, value in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return out.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.

    A transformed text holds no sentinel, and none arises where a part meets a sentinel, so each
    stands in the output once.
    """
    part = lambda text, sentinel, which: F.substring_index(text, sentinel, which)
    whole = F.col(output)
    head, middle = part(whole, MIDDLE, 1), part(whole, MIDDLE, -1)
    after_first = F.substr(head, F.lit(len(PREFIX) + 1))
    psm = F.concat(part(after_first, SUFFIX, 1), middle, part(after_first, SUFFIX, -1))
    spm = F.concat(part(after_first, PREFIX, -1), middle, part(after_first, PREFIX, 1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)


def digest(samples: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of transformed texts."""
    return samples.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


def oracle_sql(seed: int = 42, percent: int = 50, spm_percent: int = 80) -> str:
    """The query's rows as DuckDB SQL, from lists of units."""
    h = ", ".join(f"('0x' || substr(s, {1 + 8 * i}, 8))::UBIGINT::BIGINT AS h{i + 1}" for i in range(4))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT doc_id, t, {h}, regexp_extract_all(t, '{UNIT}') AS u FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
