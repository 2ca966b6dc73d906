"""Fill-in-the-middle documents, cut by bit-parallel arithmetic on big integers.

A text of m UTF-8 bytes becomes two integers of m bits, the first byte highest: `bytes.translate` turns each byte into the digit of its class, letters
in one mask and first bytes of code points in the other. A token is a run of letters or any other single code point, so its first byte is a
letter that follows no letter, or the first byte of a code point that is no letter: two shifted boolean operations mark all starts at once.
`bit_count` counts them, and the start of the k-th token is found by halving: the count of the upper half says in which half it lies.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import pieces, table, utf8

LETTER = bytes(48 + (65 <= c <= 90 or 97 <= c <= 122) for c in range(256))
LEAD = bytes(48 + (not 128 <= c < 192) for c in range(256))
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def masks(text: bytes) -> tuple[int, int]:
    """(starts of tokens, first bytes of code points) of a UTF-8 text, a bit for each byte, the first byte highest."""
    if not text:
        return 0, 0
    letters, lead = int(text.translate(LETTER), 2), int(text.translate(LEAD), 2)
    return (letters ^ (letters & letters >> 1)) | (lead & ~letters), lead


def select(bits: int, width: int, k: int) -> int:
    """The place, from the highest of `width` bits, of the set bit that has k set bits above it; `width` if there is none."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        above = high.bit_count()
        if k < above:
            bits, width = high, width - low
        else:
            bits, width, k, at = bits & ((1 << low) - 1), low, k - above, at + width - low
    return at


def infilled_text(text: bytes, h: tuple[int, int, int, int], rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, characters of the prefix, of the middle, output) of a text, cut by the four numbers h."""
    starts, lead = masks(text)
    n = starts.bit_count()
    if not text or h[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    units = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (select(starts, len(text), k) for k in units)
    to_a, to_b = ((lead >> (len(text) - x)).bit_count() for x in (a, b))
    one, two, three = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, SPM, to_a, to_b - to_a, b"".join((SUFFIX, three, PREFIX, one, MIDDLE, two))
    return n, PSM, to_a, to_b - to_a, b"".join((PREFIX, one, SUFFIX, three, MIDDLE, two))


SHAPES = {PSM: re.compile(rb"<P>(.*?)<S>(.*?)<M>(.*)", re.S), SPM: re.compile(rb"<S>(.*?)<P>(.*?)<M>(.*)", re.S)}


def restored_text(output: bytes, form: str) -> bytes:
    """The text of an output. Texts that hold a mark are plain, and no mark can begin within another one, so the first marks are those that were put there."""
    if form == PLAIN:
        return output
    one, two, three = SHAPES[form].fullmatch(output).groups()
    return one + three + two if form == PSM else two + three + one


def infilled(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, row) for every row: the text in fill-in-the-middle form.

    The cut, whether the text is cut (for `rate` in a hundred), and in which order its parts come (for `spm` in a hundred the suffix first) follow from the digest of the seed and the id alone, so repeated rows come out alike
    and a lost task comes out the same again. `row` is a struct of the columns named in `keep` (null for none); other columns are ignored, whatever their names. A null text is empty; empty texts, and texts with a mark in them, are
    plain. A null id is hashed as an empty one. One unit of a text may be longer than any batch; an empty table gives an empty result. No row is moved: there is no shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    row = F.struct(*keep) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), *numbers, utf8(text_col).alias("t"))

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "t"):
                got = [infilled_text(t, h, rate, spm) for t, *h in zip(b.column("t").to_pylist(), *(b.column(f"h{k}").to_pylist() for k in range(4)))]
                n, form, one, two, out = zip(*got)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(out, pa.binary()), b.column("row")], names)

    kind = rows.schema["row"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "row"]
    out = rows.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, row {kind}")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(out: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """`out` of infilled() with the column `restored`, the text of each output; a column of that name is replaced. A null output gives null."""
    text, form = F.col(output_col), F.col(form_col)
    marks = {m: F.locate(m, text) for m in ("<P>", "<S>", "<M>")}
    between = lambda a, b: F.substr(text, marks[a] + 3, marks[b] - marks[a] - 3)
    middle = F.substr(text, marks["<M>"] + 3)
    return out.withColumn("restored", F.when(form == PSM, F.concat(between("<P>", "<S>"), middle, between("<S>", "<M>"))).when(form == SPM, F.concat(between("<P>", "<M>"), middle, between("<S>", "<P>"))).otherwise(text))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form: digests of the output and of the text rebuilt from it."""
    rows = infilled(table(spark, sf_dir, "documents"))

    def run(batches):
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            form, out = b.column("form").to_pylist(), b.column("output").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(map(digest, out)), pa.array([digest(restored_text(o, f)) for o, f in zip(out, form)])], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = rows.withColumn("output", F.col("output").cast("binary")).select(*names[:5], "output")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE_OP12 = r"""
with d as (
  select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as unit, sha256('1:' || cast(doc_id as varchar)) as h from documents
), k as (
  select *, len(unit) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from k
), p as (
  select doc_id, n, form, x, array_to_string(unit[1:a], '') as one, array_to_string(unit[a + 1:b], '') as two, array_to_string(unit[b + 1:n], '') as three from c
)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(one) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(two) end as bigint) as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || one || '<S>' || three || '<M>' || two else '<S>' || three || '<P>' || one || '<M>' || two end) as output_sha256, sha256(x) as restored_sha256
from p
"""
