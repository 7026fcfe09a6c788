"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put together anew for training.

A text is cut between units: a unit is a run of other characters with the white space before it, or the white space at the
end of the text. A hash of `seed` and the document's id draws two cuts, whether the document stays plain, and the order of
the parts. The kernel works on the UTF-8 buffers of an Arrow column, for all rows of a batch together: a lookup by byte
tells white space, the mask of adjacent bytes tells where units end, its running count less that at a document's start
numbers the units, and a binary search for the drawn numbers gives all cuts at once. A batch is taken in pieces of about
piece_bytes of text, so that memory is bounded by that or by the longest text. There is no shuffle.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay plain. A null id counts as an
empty one; repeated rows give the same. Columns of the input named like new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
PIECE_BYTES = 4 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that don't begin a code point.
FOLLOWS = (np.arange(256) & 0xC0) == 0x80
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the positions where its rows begin, one more than rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cut(raw: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the documents raw[at[i]:at[i + 1]]: their numbers of units; the positions of both cuts, and the numbers of code
    points before the first and between them; whether they hold a sentinel. first, second: the hashes of the cuts."""
    start, end = at[:-1], at[1:]
    full = end > start
    space = SPACE[raw]
    ends = np.zeros(len(raw) + 1, bool)  # whether a unit ends at a byte
    ends[:-2] = ~space[:-1] & space[1:]
    ends[end[full] - 1] = True
    total = np.zeros(len(raw) + 1, np.int64)  # units, code points before a position
    np.cumsum(ends[:-1], out=total[1:])
    units = total[end] - total[start]
    low = np.minimum(first % (units + 1), second % (units + 1))
    high = np.maximum(first % (units + 1), second % (units + 1))
    places = [np.where(k > 0, np.searchsorted(total, total[start] + k), start) for k in (low, high)]
    np.cumsum(~FOLLOWS[raw], out=total[1:])
    chars = total[places[0]] - total[start], total[places[1]] - total[places[0]]
    marks = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        marks[:-3] = (raw[:-2] == ord("<")) & np.isin(raw[1:-1], [ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]) & (raw[2:] == ord(">"))
    found = np.flatnonzero(marks)
    owner = np.searchsorted(at, found, "right") - 1
    marked = np.zeros(len(start), bool)
    marked[owner[found + 3 <= at[owner + 1]]] = True
    return units, *places, *chars, marked


def transformed(texts: pa.Array, hashes: list[np.ndarray], rate: int, spm_rate: int) -> pa.Array:
    """The parts of all rows of one piece."""
    raw, at = utf8_buffer(texts)
    units, low, high, before, between, marked = cut(raw, at, hashes[0], hashes[1])
    plain = (at[1:] == at[:-1]) | marked | (hashes[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(hashes[3] % 100 < spm_rate, 2, 1))
    view, p, s, m = memoryview(raw), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for kind, a, b, c, d in zip(form.tolist(), at[:-1].tolist(), low.tolist(), high.tolist(), at[1:].tolist(), strict=True):
        parts = (view[a:d],) if kind == 0 else (p, view[a:b], s, view[c:d], m, view[b:c]) if kind == 1 else (s, view[c:d], p, view[a:b], m, view[b:c])
        out.append(b"".join(parts))
    return pa.StructArray.from_arrays(
        [
            pa.array(units), pa.DictionaryArray.from_arrays(pa.array(form), pa.array(FORMS)).dictionary_decode(),
            pa.array(before, mask=plain), pa.array(between, mask=plain), pa.array(out, pa.binary()).view(pa.string()),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fim_column(text: Column, doc_id: Column, rate: int, spm_rate: int, seed: int, piece_bytes: int = PIECE_BYTES) -> Column:
    """The struct of PARTS."""

    @arrow_udf(f"struct<{', '.join(':'.join(f.split()) for f in PARTS.split(', '))}>")
    def kernel(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        hashes = [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]
        _, at = utf8_buffer(texts)
        done, pieces = 0, []
        while done < len(texts):
            upto = max(done + 1, int(np.searchsorted(at, at[done] + piece_bytes, "right")) - 1)
            pieces.append(transformed(texts[done:upto], [h[done:upto] for h in hashes], rate, spm_rate))
            done = upto
        return pa.concat_arrays(pieces) if pieces else transformed(texts, hashes, rate, spm_rate)

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return kernel(text, *[F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs and the columns of PARTS. rate: per cent of documents that are cut; spm_rate: per cent of these whose suffix
    comes first."""
    done = docs.withColumn("__fim", fim_column(F.col("text").cast("string"), F.col("doc_id"), rate, spm_rate, seed, piece_bytes))
    return done.withColumns({f.split()[0]: F.col("__fim")[f.split()[0]] for f in PARTS.split(", ")}).drop("__fim")


def restored(output: Column, form: Column) -> Column:
    """The exact text: no part holds a sentinel, so each stands where it was put."""
    part = lambda text, mark, i: F.split_part(text, F.lit(mark), F.lit(i))
    middle = part(output, MIDDLE, 2)
    suffix_last = F.concat(F.substr(part(output, SUFFIX, 1), F.lit(4)), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    suffix_first = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, F.substr(part(output, PREFIX, 1), F.lit(4)))
    return F.when(form == "psm", suffix_last).when(form == "spm", suffix_first).otherwise(output)
