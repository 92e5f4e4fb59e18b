"""Scripts of texts from the names of their letters, by a binary search in ranges of code points."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from corpusloom.functions.arrow_bytes import buffers

#: What stands for no letter, and for a letter without a name.
NO_LETTER, UNNAMED = "nonalpha", "UNK"


@cache
def ranges() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ascending first code points of ranges, the number of each range's script, and the scripts.

    Made once in a process, from the rule that a letter's script is the first word of its name; code
    points that are no letters have the script NO_LETTER.
    """
    names = [NO_LETTER]
    number = {NO_LETTER: 0}
    starts, kinds, last = [], [], None
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        name = (unicodedata.name(ch, "") or UNNAMED).split()[0] if ch.isalpha() else NO_LETTER
        if name != last:
            if name not in number:
                number[name] = len(names)
                names.append(name)
            starts.append(c)
            kinds.append(number[name])
            last = name
    return np.array(starts, dtype=np.int64), np.array(kinds, dtype=np.int64), names


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, the row of each, and which rows are not whole UTF-8.

    A row with a byte that begins no character, a character that is cut off, written too long, beyond
    the last code point, or that is half a surrogate pair is not whole.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lead = (data & 0xC0) != 0x80
    n = len(data)
    size = np.ones(n, dtype=np.int64)
    for bound, s in ((0xC2, 2), (0xE0, 3), (0xF0, 4)):
        size[data >= bound] = s
    bad = np.zeros(len(offsets) - 1, dtype=bool)
    bad[row[(data >= 0xF5) | (data == 0xC0) | (data == 0xC1)]] = True
    at = np.flatnonzero(lead)
    # A character reaches to just before the next one, or to the end of its row.
    following = np.append(at[1:], n)
    end = np.minimum(following, offsets[1:][row[at]]) if len(at) else at
    bad[row[at[end - at != size[at]]]] = True
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    bad[row[first[~lead[first]]]] = True
    points = np.where(size[at] == 1, data[at], data[at] & (0x7F >> size[at])).astype(np.int64)
    for k in (1, 2, 3):
        more = size[at] > k
        points[more] = points[more] << 6 | (data[np.minimum(at[more] + k, n - 1)] & 0x3F)
    least = np.array([0, 0, 0x80, 0x800, 0x10000])[size[at]]
    bad[row[at[(points < least) | (points > 0x10FFFF) | ((points >= 0xD800) & (points < 0xE000))]]] = True
    return points, row[at], bad


def scripts(column: pa.Array) -> pa.Array:
    """Script of each row of bytes: the one that all letters have, mixed, nonalpha without letters, partial where the bytes are not whole UTF-8; null is nonalpha."""
    starts, kinds, names = ranges()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        # The same bytes read as text; nothing is decoded.
        column = column.cast(pa.large_binary())
        column = pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), column.null_count, column.offset)
    data, offsets = buffers(column)
    points, row, bad = code_points(data, offsets)
    kind = kinds[np.searchsorted(starts, points, side="right") - 1]
    letter = kind > 0
    least, most = np.full(len(offsets) - 1, len(names)), np.zeros(len(offsets) - 1, dtype=np.int64)
    np.minimum.at(least, row[letter], kind[letter])
    np.maximum.at(most, row[letter], kind[letter])
    words = np.array([*names, NO_LETTER], dtype=object)
    out = np.where(least < most, "mixed", words[least])
    out[bad] = "partial"
    return pa.array(out.tolist(), pa.string())
