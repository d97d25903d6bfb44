"""Functions on k-mers: strings over acgt, with `$` where a label is padded.

All are expressions of built-in functions, so they stay inside generated code and are pushed and pruned by the optimizer.
Colexicographic order (by last symbol first) is the plain order of the reversed string, as `$` < a < c < g < t.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DUMMY, SYMBOLS, ALPHABET = "$", "acgt", "$acgt"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(s: Column | str) -> Column:
    """Reverse complement; `$` stays."""
    return F.translate(F.reverse(_col(s)), "acgt", "tgca")


def start_node(s: Column | str, k: int) -> Column:
    return F.substring(_col(s), 1, k - 1)


def end_node(s: Column | str, k: int) -> Column:
    return F.substring(_col(s), 2, k - 1)


def start_node_suffix(s: Column | str, k: int) -> Column:
    """The start node without its first symbol."""
    return F.substring(_col(s), 2, k - 2)


def edge_symbol(s: Column | str, k: int) -> Column:
    return F.substring(_col(s), k, 1)


def symbol_from_end(s: Column | str, i: int, k: int) -> Column:
    """The i-th symbol counted from the end, from 0."""
    return F.substring(_col(s), k - i, 1)


def set_symbol(s: Column | str, i: int, symbol: str, k: int) -> Column:
    """The k-mer with its i-th symbol from the end replaced."""
    return F.overlay(_col(s), F.lit(symbol), F.lit(k - i), F.lit(1))


def clear_symbol(s: Column | str, i: int, k: int) -> Column:
    return set_symbol(s, i, "a", k)


def symbol_range(s: Column | str, lo: int, hi: int, k: int) -> Column:
    """Symbols lo to hi (exclusive), counted from the end, in reading order."""
    return F.substring(_col(s), k - hi + 1, hi - lo)


def colex_key(s: Column | str) -> Column:
    return F.reverse(_col(s))


def canonical(s: Column | str) -> Column:
    """The colexicographically smaller of a k-mer and its reverse complement."""
    s, rc = _col(s), revcomp(s)
    return F.when(colex_key(s) <= F.reverse(rc), s).otherwise(rc)


def is_palindrome(s: Column | str) -> Column:
    """Equal to its own reverse complement; only even k can be."""
    s = _col(s)
    return (F.length(s) % 2 == 0) & (s == revcomp(s))


def follow(s: Column | str, symbol: Column, k: int) -> Column:
    """Drop the first symbol and append another."""
    return F.concat(F.substring(_col(s), 2, k - 1), symbol)


def padded(s: Column | str, width: int) -> Column:
    """Left-padded with `$`."""
    return F.lpad(_col(s), width, DUMMY)


def swap_gt(s: Column | str) -> Column:
    """Between the counter's symbol order a, c, t, g and the graph's a, c, g, t."""
    return F.translate(_col(s), "gt", "tg")


def symbol_code(c: Column | str) -> Column:
    """0 to 4 for `$`, a, c, g, t."""
    c = _col(c)
    return F.when(c == "a", 1).when(c == "c", 2).when(c == "g", 3).when(c == "t", 4).otherwise(0).cast("long")


def label_symbol(code: Column) -> Column:
    """The upper-case letter of a code."""
    return F.substring(F.lit("$ACGT"), (code + 1).cast("int"), F.lit(1))


def common_prefix(a: Column | str, b: Column | str, width: int) -> Column:
    """Length of the longest common prefix that holds no `$`, at most width: steps of halves, each a comparison of bytes."""
    a, b = (_col(x).cast("binary") for x in (a, b))
    steps = [1 << i for i in reversed(range(width.bit_length()))]
    same = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + F.when((n + s <= width) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), s).otherwise(0))
    plain = F.locate(DUMMY, a.cast("string")) - 1
    return F.when(plain >= 0, F.least(same, plain)).otherwise(same).cast("long")


def common_suffix(a: Column | str, b: Column | str, width: int) -> Column:
    """Length of the longest common suffix that holds no `$`, at most width."""
    return common_prefix(F.reverse(_col(a)), F.reverse(_col(b)), width)


#: The 16 pairs of symbols as bytes, with a nibble for each symbol, and as a nibble for the pair.
_PAIRS, _HEX = "".join(chr(16 * i + j) for i in range(1, 5) for j in range(1, 5)), "0123456789ABCDEF"


def packed(s: Column | str, width: int) -> Column:
    """A label of this width as bytes, two bits a symbol, whose order is the label's; `$` counts as `a`."""
    s = _col(s) if width % 4 == 0 else F.rpad(_col(s), width + -width % 4, "a")
    pairs = F.unhex(F.translate(s, "acgt$", "12341")).cast("string")
    return F.unhex(F.translate(pairs, _PAIRS, _HEX))


def label(code: Column | str, width: int) -> Column:
    """The label that was packed."""
    return F.substring(F.translate(F.hex(F.translate(F.hex(_col(code)), _HEX, _PAIRS)), "1234", SYMBOLS), 1, width)
