"""Fill-in-the-middle transformation: unit boundaries of a text as the bits of one whole number.

A text is worked on as its UTF-8 bytes. bytes.translate marks a class of bytes, the marks are read as
one number with a bit for each byte, shifts and boolean operations turn classes into the starts of
units, bit_count counts them, and a start of a given rank is found by halving the number again and again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import read, shielded

MARKS = ("<P>", "<S>", "<M>")
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
#: Rows that are worked on together, so that what is held besides a batch is small.
ROWS = 256


def marks_of(members: bytes) -> bytes:
    """The table that turns bytes of a class into '1' and all others into '0'."""
    return bytes(49 if b in members else 48 for b in range(256))


LINE_ENDS = marks_of(b"\n")
WHITE = marks_of(b" \t\n\v\f\r")
#: All bytes but those that go on with a code point.
LEADS = marks_of(bytes(b for b in range(256) if b & 0xC0 != 0x80))


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is in the class."""
    return int(data[::-1].translate(table), 2) if data else 0


def starts(data: bytes, unit: str) -> int:
    """Bit i is set if a unit starts at byte i.

    A `line` goes up to its line break, which it includes. A `word` goes up to the next word, so it
    includes the white space after it; white space that a text begins with is a unit. A `char` is a
    code point.
    """
    whole = (1 << len(data)) - 1
    if unit == "line":
        return (mask(data, LINE_ENDS) << 1 | 1) & whole
    if unit == "word":
        white = mask(data, WHITE)
        return (white << 1 & ~white | 1) & whole
    if unit == "char":
        return mask(data, LEADS)
    raise ValueError(f"no such unit: {unit}")


def ranked(bits: int, width: int, rank: int) -> int:
    """The place of the set bit that has `rank` set ones below it, among `width` bits."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def drawn(id: object, seed: int) -> list[int]:
    """Four numbers for a document: the first 8-digit groups of the hex SHA-256 of seed:id."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(
    text: str, id: object, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS
) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = text.encode()
    bits = starts(data, unit)
    n = bits.bit_count()
    h1, h2, h3, h4 = drawn(id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = (len(data) if rank == n else ranked(bits, len(data), rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = mask(data, LEADS)
    before = (leads & ((1 << first) - 1)).bit_count()
    inside = (leads & ((1 << second) - 1)).bit_count() - before
    prefix, middle, suffix = (part.decode() for part in (data[:first], data[first:second], data[second:]))
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return n, "spm", before, inside, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", before, inside, f"{p}{prefix}{s}{suffix}{m}{middle}"


@shielded
def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    unit: str = "line",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """docs without the text, with n (units), form, prefix_chars, middle_chars and output.

    The text is cut into prefix, middle and suffix at two units that a hash of the id draws, and is put
    together again as prefix, suffix, middle (form psm) or suffix, prefix, middle (spm), each behind its
    mark. A text that is empty or null, or holds a mark, stays as it is (form plain, null lengths), as
    do all but `rate` in a hundred. A null id counts as ''. Rows that repeat an id are cut at the same
    draw; a repeated row gives the same result again. Own columns with the names added here are replaced.
    """
    if len(set(marks)) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks are three different names in angle brackets")
    rest = [c for c in docs.columns if c not in (text, *ADDED)]
    kinds = "_n long, _form string, _prefix long, _middle long, _output string"
    schema = docs.select(*rest, *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")]).schema

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                pairs = zip(part.column("_own").to_pylist(), part.column("_id").to_pylist(), strict=True)
                n, form, prefix, middle, output = zip(*[transformed(t or "", i, unit, seed, rate, spm_rate, marks) for t, i in pairs], strict=True)
                found = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *found], names=schema.names)

    named = dict(zip(schema.names[-5:], ADDED, strict=True))
    return docs.select(*rest, F.col(text).alias("_own"), F.col(id).alias("_id")).mapInArrow(told, schema).withColumnsRenamed(named)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of. No part holds a mark, so the marks part it."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    found = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (
  SELECT doc_id, t, n, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid,
         array_to_string(list_slice(u, b + 1, n), '') AS suf,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
