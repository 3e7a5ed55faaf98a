"""Fill-in-the-middle rewriting of whole texts, cut by bit-parallel counting over big integers.

A text's UTF-8 bytes become masks of one bit a byte: ``bytes.translate`` writes the class of each byte as a
binary digit, and the digits are read as one integer, the first byte lowest. Letters that follow a letter are
told by a shift and an AND, so a few operations on whole texts mark where each token begins: a run of ASCII
letters, or any other code point. ``bit_count`` gives the number of tokens n, and the place of a token is
found by halving the mask again and again, by the number of bits in its lower half. Python returns three
numbers a text; texts are put together, and taken apart again, by Spark expressions.

What is drawn follows from the id alone: the first four groups of eight digits of the SHA-256 of
``<seed>:<id>``, as unsigned integers, give the two cuts and the form.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain, so
every output can be taken apart; a null id draws as an empty one; rows that repeat are rewritten alike; an
empty table gives no rows; other columns stay, but a column of the input named as one of ``COLUMNS`` is an
error. Texts of any length are taken whole: time and memory follow their length, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Added by ``fill_in_middle``; lengths are of code points, null where the form is plain.
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")

_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
_INNER = bytes(49 if b & 0xC0 == 0x80 else 48 for b in range(256))  # bytes that go on with a code point


def masks(text: bytes) -> tuple[int, int]:
    """(where tokens begin, where code points begin): a bit a byte, the first byte lowest."""
    if not text:
        return 0, 0
    back = text[::-1]
    letters, inner = int(back.translate(_LETTERS), 2), int(back.translate(_INNER), 2)
    points = ((1 << len(text)) - 1) ^ inner
    return points & ~(letters & (letters << 1)) | 1, points | 1


def nth_bit(mask: int, width: int, n: int) -> int:
    """Place of the set bit that has ``n`` set bits below it; ``mask`` has more than ``n`` and at most ``width`` bits."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if n < below:
            mask, width = low, half
        else:
            mask, width, n, place = mask >> half, width - half, n - below, place + half
    return place


def cuts(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """(tokens, code points of the prefix, of the middle), for two drawn numbers."""
    starts, points = masks(text)
    n = starts.bit_count()
    chars = []
    for rank in sorted((first % (n + 1), second % (n + 1))):
        at = nth_bit(starts, len(text), rank) if rank < n else len(text)
        chars.append((points & ((1 << at) - 1)).bit_count())
    return n, chars[0], chars[1] - chars[0]


def _cut_batches(text: Column, first: Column, second: Column) -> Column:
    @F.arrow_udf("n long, prefix_chars long, middle_chars long")
    def run(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = [cuts(t.as_buffer().to_pybytes(), x, y) for t, x, y in zip(texts, a.to_pylist(), b.to_pylist(), strict=True)]
        table = np.array(found, np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(3)], names=["n", "prefix_chars", "middle_chars"])

    return run(text, first, second)


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits that follow from seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rewritten: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with ``COLUMNS``. Of 100 texts ``rewritten`` change form, and of 100 such ``spm`` put the suffix first."""
    if clash := sorted(set(COLUMNS) & set(docs.columns)):
        raise ValueError(f"columns {clash} are there already")
    if len({s[0] for s in sentinels}) > 1 or any(s[0] in s[1:] for s in sentinels):
        raise ValueError("sentinels must begin with one character that comes nowhere else in them")  # else a text's end could make one
    h = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = (F.length(text) == 0) | (h[2] % 100 >= rewritten)
    for s in sentinels:
        held = held | F.contains(text, F.lit(s))
    rows = docs.withColumns({"__text": text, "__plain": held, "__cut": _cut_batches(text.cast("binary"), h[0], h[1])})
    prefix, middle = F.col("__cut.prefix_chars"), F.col("__cut.middle_chars")
    parts = [F.substring("__text", F.lit(1), prefix.cast("int")), F.substring("__text", (prefix + 1).cast("int"), middle.cast("int"))]
    parts.append(F.substring("__text", (prefix + middle + 1).cast("int"), F.lit(2**31 - 1)))
    p, s, m = (F.lit(x) for x in sentinels)
    form = F.when(F.col("__plain"), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    whole = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "psm", F.concat(p, parts[0], s, parts[2], m, parts[1]))
    shown = {name: F.when(F.col("form") != "plain", F.col(f"__cut.{name}")) for name in COLUMNS[2:4]}
    done = rows.withColumns({"n": F.col("__cut.n"), "form": form}).withColumns(shown | {"output": whole.otherwise(F.concat(s, parts[2], p, parts[0], m, parts[1]))})
    return done.select(*docs.columns, *COLUMNS)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> list[Column]:
        """What follows ``first``, ``second`` and the middle's sentinel, each found once, from the left."""
        head = F.length(F.lit(first)) + 1
        b, c = F.locate(second, output), F.locate(m, output)
        end = F.lit(2**31 - 1)
        return [F.substring(output, head, b - head), F.substring(output, b + len(second), c - b - len(second)), F.substring(output, c + len(m), end)]

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
